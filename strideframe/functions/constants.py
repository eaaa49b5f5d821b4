"""Fixed values that results depend on."""

# Lengths and speeds.
METRES_PER_MILE = 1609.34        # used by pace labels
METRES_PER_KM = 1000.0
CM_PER_MILE = 160934.4
CM_PER_KM = 100000.0
KM_PER_MILE = 1.609344
MILE_PACE_FACTOR = 26.8224       # minutes per mile = 26.8224 / (metres per second)

# Analysis rules.
STABILITY_MINUTES = 2.0          # half-width of the stable prediction band
BIAS_DEAD_BAND_MINUTES = 2.0
HRV_MISSING = 511                # the device writes 511 for "no HRV"
EPOCH_MS_FLOOR = 1e11            # a calendar number above this is epoch milliseconds
ROLLING_WINDOWS = (7, 15, 30)    # rows, that is run days
TAIL_ROWS = 14
TIMELINE_START = "2021-01-01"
OUTSIDE_BLOCKS = "Outside marathon blocks"
NO_MATCH = "No same-day run matched"

# Standard race distances in miles.
RACE_MILES = {"marathon": 26.2188, "half": 13.1094, "10k": 6.2137, "5k": 3.1069}

# Race type -> prediction column, and prediction column -> raw seconds column.
PREDICTION_BY_RACE_TYPE = {
    "5k": "5K_pred", "10k": "10K_pred", "half": "Half_pred", "marathon": "Marathon_pred",
}
PREDICTION_SECONDS = {
    "5K_pred": "raceTime5K",
    "10K_pred": "raceTime10K",
    "Half_pred": "raceTimeHalf",
    "Marathon_pred": "raceTimeMarathon",
}
PREDICTION_COLUMNS = tuple(PREDICTION_SECONDS)

# Activity columns that carry no analysis value and are removed.
DROPPED_ACTIVITY_COLUMNS = (
    "maxTemperature", "minTemperature", "workoutComplianceScore", "workoutId",
    "matchedCuratedCourseId", "avgVerticalSpeed", "description", "totalReps", "totalSets",
    "activeSets", "summarizedExerciseSets", "courseId", "avgRespirationRate",
    "maxRespirationRate", "minRespirationRate", "workoutRpe", "workoutFeel", "parent",
    "runPowerWindDataEnabled", "atpActivity", "elevationCorrected", "autoCalcCalories",
    "purposeful", "decoDive", "favorite", "isRunPowerWindDataEnabled",
    "anaerobicTrainingEffectMessage", "aerobicTrainingEffectMessage", "manufacturer",
    "startTimeGmt", "startTimeLocal", "rule", "eventTypeId", "uuidMsb", "uuidLsb",
    "timeZoneId", "beginTimestamp", "sportType",
)
IDENTIFYING_COLUMNS = ("userProfilePK", "deviceId")

# Columns the daily table takes from each daily source.
METRIC_COLUMNS = (
    "acwrPercent", "acwrStatus", "acwrStatusFeedback", "dailyTrainingLoadAcute",
    "dailyTrainingLoadChronic", "dailyAcuteChronicWorkloadRatio",
)
MAXMET_COLUMNS = ("vo2MaxValue", "fitnessAge", "fitnessAgeDescription", "maxMet")
