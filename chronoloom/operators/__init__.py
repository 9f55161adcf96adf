"""chronoloom.operators"""
