"""kernloom.plans"""
