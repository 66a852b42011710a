"""Readers for schedules, snapshots, weather, regions and stored tables."""
