"""docintake.streaming"""
