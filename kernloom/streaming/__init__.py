"""kernloom.streaming"""
