"""Seismic waveform analytics as Spark jobs: samples, frames, stations, picks and alerts."""
