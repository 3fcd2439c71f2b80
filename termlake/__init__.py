"""termlake: terminology-aware text analytics on Spark."""
