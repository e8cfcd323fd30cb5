"""The questions asked of the case table, each a function from DataFrame to DataFrame.

Plans read prepared cases (``prepare.prepare_cases``) or, where they only count and sum, the case
cube (``cube.build_cube``) in their place.
"""
