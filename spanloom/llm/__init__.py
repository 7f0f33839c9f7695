"""Operators of a training-data pipeline: encoding, quality, privacy, media, licences, near duplicates, mixing and HTML."""
