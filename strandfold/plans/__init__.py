"""strandfold.plans"""
