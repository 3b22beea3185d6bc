"""tremor: event-impact analytics over many series and many events, on Spark."""
