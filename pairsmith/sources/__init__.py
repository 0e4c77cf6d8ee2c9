"""pairsmith.sources"""
