"""pairsmith.functions"""
