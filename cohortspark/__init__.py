"""A PySpark-native engine for two-occasion cohort analysis.

Extracts become lazy DataFrames; the cohort funnel, censored features and
descriptive tables are DataFrame plans; models are fitted from distributed
second moments, and their coefficients return as Column expressions.
"""
