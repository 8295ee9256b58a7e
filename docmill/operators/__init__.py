"""docmill.operators"""
