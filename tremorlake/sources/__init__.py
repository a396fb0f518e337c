"""Where waveforms, samples, stations and messages come from and go to."""
