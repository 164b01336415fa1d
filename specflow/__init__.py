"""PySpark-native analytics for collections of measured curves and the literature metadata attached to them."""
