"""Relations found in the content of assets: one extractor per kind of content, one registry of what each yields."""
