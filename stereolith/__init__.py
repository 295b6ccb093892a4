"""Analytics for measurements from synchronized multi-camera video, on Spark."""
