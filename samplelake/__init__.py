"""samplelake: sample metadata, count matrices and workflow reading as Spark jobs."""
