"""Wardlight: calibration and hospital-infection analytics as Spark jobs.

Run output of a stochastic simulation (or real hospital event tables) goes in; experiment designs, monthly
incidence rates, accepted parameter sets, priors for the next stage, densities, bands and sensitivity curves
come out.  Every operator takes and returns DataFrames.
"""
