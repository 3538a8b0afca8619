"""Streaming versions of the rating, price, alert and event jobs."""
