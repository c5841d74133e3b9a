"""The modules whose queries the driver runs."""

from tapeloom.plans import cohorts, contracts, delivery_and_sessions, known, programs, reports, scalars, sequences, studies, study

FLAGSHIP = "motif_lift"
MODULES = [delivery_and_sessions, scalars, sequences, studies, programs, known, cohorts, reports, study, contracts]
