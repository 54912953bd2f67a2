"""graphloom.sinks"""
