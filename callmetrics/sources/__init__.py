"""Reading call records, recordings, events and declarations; writing outcomes."""
