"""talkmine: spoken-content analytics as DataFrame-to-DataFrame functions on Spark."""
