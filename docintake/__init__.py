"""docintake: document intake, classification, routing and filing as Spark jobs."""
