"""pairsmith.streaming"""
