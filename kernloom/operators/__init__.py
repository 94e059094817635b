"""kernloom.operators"""
