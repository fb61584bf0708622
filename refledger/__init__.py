"""refledger: bibliographic reference verification as Spark jobs."""
