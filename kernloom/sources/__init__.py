"""kernloom.sources"""
