"""docintake.sources"""
