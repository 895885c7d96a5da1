"""Operators from DataFrame to DataFrame: features, labelling rules, metrics, selection, validation, sensitivity."""
