"""Scalar building blocks: key hashes, votes over worlds, noised samples."""
