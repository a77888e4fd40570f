"""reviewloom.functions"""
