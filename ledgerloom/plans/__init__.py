"""The domain's plans over the star-schema tables."""
