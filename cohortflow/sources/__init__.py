"""Sources: the wide delimited scan and the synthetic cohort fixture."""
