"""reviewloom.plans"""
