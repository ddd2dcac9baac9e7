"""Schemas of the inputs."""

from pyspark.sql import types as T

REVIEW = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType()), T.StructField("date", T.StringType()), T.StructField("stars", T.DoubleType())])
BUSINESS = T.StructType([T.StructField("business_id", T.StringType()), T.StructField("city", T.StringType())])
PAIR = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType())])
RATING = T.StructType([*PAIR.fields, T.StructField("stars", T.DoubleType())])
CITY = T.StructType([T.StructField("city", T.StringType())])
TWEET = T.StructType([T.StructField("text", T.StringType())])
