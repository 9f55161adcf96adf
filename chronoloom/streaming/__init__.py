"""chronoloom.streaming"""
