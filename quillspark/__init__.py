"""quillspark: evidence retrieval and corpus preparation as ordinary Spark jobs."""
