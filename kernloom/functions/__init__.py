"""kernloom.functions"""
