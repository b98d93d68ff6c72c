"""DataFrame building blocks shared by the jobs."""
