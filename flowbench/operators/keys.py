"""The key that every graph table shares."""

KEY = ["dataset", "sample_id"]
