"""dyadica: Spark-native analytics of closed alternations in dialogue."""
