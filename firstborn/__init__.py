"""Bayesian clustering of ordered observations as Spark DataFrame operators.

Every table is long: one row per observation, cluster, draw or token.  A
cluster is identified by the position of its first member, so cluster ids are
themselves points on the observation axis.
"""
