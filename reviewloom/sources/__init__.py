"""reviewloom.sources"""
