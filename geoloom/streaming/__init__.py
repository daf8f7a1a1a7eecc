"""Streams of points and features, and jobs that report and can be cancelled."""
