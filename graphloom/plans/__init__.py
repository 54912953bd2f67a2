"""graphloom.plans"""
