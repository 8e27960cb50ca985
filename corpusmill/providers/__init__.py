"""Stand-ins for trained models, behind the interfaces the operators take."""
