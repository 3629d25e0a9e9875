"""docintake.plans"""
