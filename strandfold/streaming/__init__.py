"""strandfold.streaming"""
