"""docintake.operators"""
