"""docintake.functions"""
