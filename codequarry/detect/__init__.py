"""Detectors: joins over code facts."""
