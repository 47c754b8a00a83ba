"""strandfold.functions"""
