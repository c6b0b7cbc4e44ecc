"""Column functions: key encoding, transforms, digests."""
