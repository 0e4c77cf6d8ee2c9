"""pairsmith.plans"""
