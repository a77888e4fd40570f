"""reviewloom.operators"""
