"""Keyboard and mouse event analytics as Spark jobs: counts, sessions, heatmaps, calendars, liveness."""
