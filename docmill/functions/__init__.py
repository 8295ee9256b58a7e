"""docmill.functions"""
