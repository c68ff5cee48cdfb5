"""Trend models for many groups at once.

Every pass over the data is one grouped aggregate of covariate patterns; Python
only sees the small matrices of one model.
"""
