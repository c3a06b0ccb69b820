"""waymesh: road-network and vehicle-trace analytics as PySpark jobs."""
