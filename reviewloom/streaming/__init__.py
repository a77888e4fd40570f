"""reviewloom.streaming"""
