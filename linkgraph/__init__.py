"""linkgraph: entity linkage and text-corpus operators expressed as Spark jobs."""
