"""strandfold.sources"""
