"""echofield"""
