"""chronoloom.sources"""
