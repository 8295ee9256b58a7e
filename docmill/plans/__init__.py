"""docmill.plans"""
