"""PySpark-native sketched feature selection and sparse linear classification."""
