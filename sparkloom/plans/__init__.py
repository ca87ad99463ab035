"""Query plans that combine operators into answers."""
