"""chronoloom.plans"""
