"""strideframe: wearable-accelerometer and corpus analytics written as Spark jobs."""
