"""strandfold.operators"""
