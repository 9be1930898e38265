"""Sources and sinks: CSV trees, history archives, JSON, configuration, keyed stores."""
