"""Veritrail: DataFrame operators for evidence chains, manifests and their texts."""
