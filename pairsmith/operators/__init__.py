"""pairsmith.operators"""
