"""Alert-triage and text-corpus analytics as Spark jobs."""
