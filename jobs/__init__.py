"""Runnable jobs. Each module has ``run(spark, ...)``, which takes a session and plain paths, and a command line that makes the session."""
