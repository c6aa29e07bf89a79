"""quantloom: bar analytics, portfolio construction and strategy simulation on Spark DataFrames."""
