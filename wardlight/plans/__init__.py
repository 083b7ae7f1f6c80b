"""End-to-end jobs: calibration stages, predictive checks, sensitivity curves, report tables."""
