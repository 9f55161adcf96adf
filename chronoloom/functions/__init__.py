"""chronoloom.functions"""
