"""Named queries over the driver's tables and small fixtures."""
