"""Simulated tools with state for journeys: a car, and a travel agency with cards and bookings."""

from __future__ import annotations

import copy
import datetime
import random

from quern.functions.tool import Refused, Tool

SEED = 141053
# Limits of the car, places with their codes, distances, shops, fares, rates.
TANK, MILES_PER_GALLON, LITRES_PER_GALLON = 50, 20.0, 3.78541
FULL_BRAKE, PARKED_BRAKE, SLOPE = 1000, 500.0, 10.0
ZIPS = {
    "Rivermist": "83214", "Stonebrook": "74532", "Maplecrest": "56108", "Silverpine": "62947", "Shadowridge": "71354", "Sunset Valley": "83462",
    "Oakendale": "47329", "Willowbend": "52013", "Crescent Hollow": "69238", "Autumnville": "51479", "San Francisco": "94016",
}
DISTANCES = [
    ("83214", "74532", 750.0), ("56108", "62947", 320.0), ("71354", "83462", 450.0), ("47329", "52013", 290.0), ("69238", "51479", 630.0), ("94016", "83214", 980.0),
    ("94016", "94704", 600.0), ("94704", "08540", 2550.0), ("94016", "08540", 1950.0), ("62947", "47329", 1053.0), ("94016", "62947", 780.0), ("74532", "94016", 880.0),
]
TIRE_SHOP = "456 Oakwood Avenue, Rivermist, 83214"
AIRPORTS = {
    "Rivermist": "RMS", "Stonebrook": "SBK", "Maplecrest": "MPC", "Silverpine": "SVP", "Shadowridge": "SHD", "Paris": "CDG", "London": "LHR", "Sunset Valley": "SSV", "Oakendale": "OKD", "Willowbend": "WLB", "Beijing": "PEK", "Tokyo": "HND",
    "Hong Kong": "HKG", "Rome": "CIA", "Crescent Hollow": "CRH", "Autumnville": "ATV", "Pinehaven": "PHV", "Greenfield": "GFD", "San Francisco": "SFO", "Los Angeles": "LAX", "New York": "JFK", "Chicago": "ORD", "Boston": "BOS",
}
CLASSES = {"economy": 1, "business": 2, "first": 5}
RATES = {"RMB": 7, "EUR": 0.8, "JPY": 110, "GBP": 0.7, "CAD": 1.3, "AUD": 1.4, "INR": 70, "RUB": 60, "BRL": 3.8, "MXN": 20}
SUPPORT = "Thank you for contacting customer support. Your message has been received and we will get back to you shortly."
FARES = {
    ("SFO", "LAX"): 200, ("SFO", "JFK"): 500, ("SFO", "ORD"): 400, ("SFO", "BOS"): 450, ("SFO", "RMS"): 300, ("SFO", "SBK"): 350, ("SFO", "MPC"): 370, ("SFO", "SVP"): 320, ("SFO", "SHD"): 330,
    ("SFO", "SSV"): 340, ("SFO", "OKD"): 360, ("SFO", "WLB"): 310, ("SFO", "CRH"): 380, ("SFO", "ATV"): 390, ("SFO", "PHV"): 420, ("SFO", "GFD"): 430, ("SFO", "CIA"): 700, ("LAX", "SFO"): 100,
    ("LAX", "JFK"): 600, ("LAX", "ORD"): 500, ("LAX", "BOS"): 550, ("LAX", "RMS"): 310, ("LAX", "SBK"): 320, ("LAX", "MPC"): 330, ("LAX", "SVP"): 340, ("LAX", "SHD"): 350, ("LAX", "SSV"): 360,
    ("LAX", "OKD"): 370, ("LAX", "WLB"): 380, ("LAX", "CRH"): 390, ("LAX", "ATV"): 400, ("LAX", "PHV"): 410, ("LAX", "GFD"): 420, ("LAX", "HND"): 430, ("JFK", "ORD"): 300, ("JFK", "BOS"): 250,
    ("JFK", "RMS"): 450, ("JFK", "SBK"): 460, ("JFK", "MPC"): 470, ("JFK", "SVP"): 480, ("JFK", "SHD"): 490, ("JFK", "SSV"): 500, ("JFK", "OKD"): 510, ("JFK", "WLB"): 520, ("JFK", "CRH"): 530,
    ("JFK", "ATV"): 540, ("JFK", "PHV"): 550, ("JFK", "GFD"): 560, ("JFK", "LAX"): 570, ("JFK", "HND"): 800, ("JFK", "PVG"): 950, ("JFK", "PEK"): 1000, ("ORD", "LAX"): 180, ("ORD", "BOS"): 200,
    ("ORD", "RMS"): 350, ("ORD", "SBK"): 360, ("ORD", "MPC"): 370, ("ORD", "SVP"): 380, ("ORD", "SHD"): 390, ("ORD", "SSV"): 400, ("ORD", "OKD"): 410, ("ORD", "WLB"): 420, ("ORD", "CRH"): 430,
    ("ORD", "ATV"): 440, ("ORD", "PHV"): 450, ("ORD", "GFD"): 460, ("BOS", "RMS"): 400, ("BOS", "SBK"): 410, ("BOS", "MPC"): 420, ("BOS", "SVP"): 430, ("BOS", "SHD"): 440, ("BOS", "SSV"): 450,
    ("BOS", "OKD"): 460, ("BOS", "WLB"): 470, ("BOS", "CRH"): 480, ("BOS", "ATV"): 490, ("BOS", "PHV"): 500, ("BOS", "GFD"): 510, ("RMS", "BOS"): 200, ("RMS", "JFK"): 210, ("RMS", "SBK"): 220,
    ("RMS", "MPC"): 230, ("RMS", "SVP"): 240, ("RMS", "SHD"): 250, ("RMS", "SSV"): 260, ("RMS", "OKD"): 270, ("RMS", "WLB"): 280, ("RMS", "CRH"): 290, ("RMS", "ATV"): 300, ("RMS", "PHV"): 310,
    ("RMS", "GFD"): 320, ("RMS", "LAX"): 330, ("SBK", "MPC"): 200, ("SBK", "SVP"): 210, ("SBK", "SHD"): 220, ("SBK", "SSV"): 230, ("SBK", "OKD"): 240, ("SBK", "WLB"): 250, ("SBK", "CRH"): 260,
    ("SBK", "ATV"): 270, ("SBK", "PHV"): 280, ("SBK", "GFD"): 290, ("MPC", "SVP"): 210, ("MPC", "SHD"): 220, ("MPC", "SSV"): 230, ("MPC", "OKD"): 240, ("MPC", "WLB"): 250, ("MPC", "CRH"): 260,
    ("MPC", "ATV"): 270, ("MPC", "PHV"): 280, ("MPC", "GFD"): 290, ("SVP", "SHD"): 230, ("SVP", "SSV"): 240, ("SVP", "OKD"): 250, ("SVP", "WLB"): 260, ("SVP", "CRH"): 270, ("SVP", "ATV"): 280,
    ("SVP", "PHV"): 290, ("SVP", "GFD"): 300, ("SHD", "SSV"): 220, ("SHD", "OKD"): 230, ("SHD", "WLB"): 240, ("SHD", "CRH"): 250, ("SHD", "ATV"): 260, ("SHD", "PHV"): 270, ("SHD", "GFD"): 280,
    ("SSV", "OKD"): 240, ("SSV", "WLB"): 250, ("SSV", "CRH"): 260, ("SSV", "ATV"): 270, ("SSV", "PHV"): 280, ("SSV", "GFD"): 290, ("OKD", "WLB"): 230, ("OKD", "CRH"): 240, ("OKD", "ATV"): 250,
    ("OKD", "PHV"): 260, ("OKD", "GFD"): 270, ("WLB", "CRH"): 250, ("WLB", "ATV"): 260, ("WLB", "PHV"): 270, ("WLB", "GFD"): 280, ("CRH", "ATV"): 240, ("CRH", "PHV"): 250, ("CRH", "GFD"): 260,
    ("CRH", "SFO"): 270, ("CRH", "RMS"): 280, ("CRH", "HKG"): 290, ("CRH", "JFK"): 300, ("ATV", "PHV"): 230, ("ATV", "GFD"): 240, ("PHV", "GFD"): 220, ("LHR", "CDG"): 100, ("OKD", "LAX"): 220,
    ("USD", "RMB"): 7, ("USD", "JPY"): 110, ("USD", "INR"): 70, ("USD", "RUB"): 60, ("USD", "MXN"): 20,
}


def fare(start: str, end: str, travel_class: str, date: str) -> float:
    """The price of a flight: by class, doubled on dates whose digits sum up to an even number."""
    if (start, end) not in FARES:
        raise ValueError("No available route for the given airports.")
    if travel_class not in CLASSES:
        raise ValueError("Invalid travel class. Options are: economy, business, first.")
    even = sum(int(c) for c in date if c.isdigit()) % 2 == 0
    return float(FARES[start, end] * CLASSES[travel_class] * (2 if even else 1))


class Vehicle(Tool):
    """A car. What a call may show of it is a table of parts; forces of the brakes and the slope are no state."""

    DEFAULT = {
        "fuelLevel": 0.0, "batteryVoltage": 12.6, "engineState": "stopped", "remainingUnlockedDoors": 4,
        "doorStatus": {"driver": "unlocked", "passenger": "unlocked", "rear_left": "unlocked", "rear_right": "unlocked"},
        "acTemperature": 25.0, "fanSpeed": 50, "acMode": "auto", "humidityLevel": 50.0, "headLightStatus": "off", "parkingBrakeStatus": "released",
        "brakePedalStatus": "released", "distanceToNextVehicle": 50.0, "cruiseStatus": "inactive", "destination": "None",
        "frontLeftTirePressure": 32.0, "frontRightTirePressure": 32.0, "rearLeftTirePressure": 30.0, "rearRightTirePressure": 30.0,
    }
    TIRES = ("frontLeftTirePressure", "frontRightTirePressure", "rearLeftTirePressure", "rearRightTirePressure")
    #: What the status of a part shows: the name shown, and where it is kept.
    PARTS = {
        "fuel": {"fuelLevel": "fuelLevel"}, "battery": {"batteryVoltage": "batteryVoltage"}, "doors": {"doorStatus": "doorStatus"},
        "climate": {"currentACTemperature": "acTemperature", "fanSpeed": "fanSpeed", "climateMode": "acMode", "humidityLevel": "humidityLevel"},
        "headlights": {"headlightStatus": "headLightStatus"}, "parkingBrake": {"parkingBrakeStatus": "parkingBrakeStatus", "parkingBrakeForce": "parked", "slopeAngle": "slope"},
        "brakePedal": {"brakePedalStatus": "brakePedalStatus", "brakePedalForce": "pressed"}, "engine": {"engineState": "engineState"},
    }

    def _setup(self, config: dict) -> None:
        self._chance = random.Random(config.get("random_seed", SEED))
        self["remainingUnlockedDoors"] = 4 - sum(s == "locked" for s in self["doorStatus"].values())
        self._force = {"parked": config.get("parkingBrakeForce", 0.0), "pressed": config.get("brakePedalForce", 0.0), "slope": config.get("slopeAngle", 0.0)}

    def startEngine(self, ignitionMode: str):
        if ignitionMode == "STOP":
            self["engineState"] = "stopped"
        unlocked = [d for d, s in self["doorStatus"].items() if s == "unlocked"]
        self._need(self["remainingUnlockedDoors"] <= 0, "All doors must be locked before starting the engine. Here are the unlocked doors: " + ", ".join(unlocked))
        self._need(self["brakePedalStatus"] == "pressed", "Brake pedal needs to be pressed when starting the engine.")
        self._need(self._force["pressed"] == FULL_BRAKE, "Must press the brake fully before starting the engine.")
        self._need(self["fuelLevel"] >= 0, "Fuel tank is empty.")
        self._need(ignitionMode == "START", "Invalid ignition mode.")
        self["engineState"] = "running"
        return {k: self[k] for k in ("engineState", "fuelLevel", "batteryVoltage")}

    def fillFuelTank(self, fuelAmount: float):
        self._need(fuelAmount >= 0, "Fuel amount cannot be negative.")
        self._need(self["fuelLevel"] + fuelAmount <= TANK, "Cannot fill gas above the tank capacity.")
        self._need(self["fuelLevel"] + fuelAmount >= 0, "Fuel tank is empty. Min fuel level is 0 gallons.")
        self["fuelLevel"] += fuelAmount
        return {"fuelLevel": self["fuelLevel"]}

    def lockDoors(self, unlock: bool, door: list):
        now, change = ("unlocked", 1) if unlock else ("locked", -1)
        for d in door:
            if self["doorStatus"][d] != now:
                self["doorStatus"][d] = now
                self["remainingUnlockedDoors"] += change
        return {"lockStatus": now, "remainingUnlockedDoors": self["remainingUnlockedDoors"]}

    def adjustClimateControl(self, temperature: float, unit: str = "celsius", fanSpeed: int = 50, mode: str = "auto"):
        self._need(0 <= fanSpeed <= 100, "Fan speed must be between 0 and 100.")
        self.state.update(acTemperature=(temperature - 32) * 5 / 9 if unit == "fahrenheit" else temperature, fanSpeed=fanSpeed, acMode=mode)
        return {"currentACTemperature": temperature, "climateMode": mode, "humidityLevel": self["humidityLevel"]}

    def get_outside_temperature_from_google(self):
        return {"outsideTemperature": self._chance.uniform(-10.0, 40.0)}

    def get_outside_temperature_from_weather_com(self):
        return {"error": 404}

    def setHeadlights(self, mode: str):
        self._need(mode in ("on", "off", "auto"), "Invalid headlight mode.")
        self["headLightStatus"] = "on" if mode == "on" else "off"
        return {"headlightStatus": self["headLightStatus"]}

    def displayCarStatus(self, option: str):
        self._need(option in self.PARTS, "Invalid option")
        return {shown: self._force[kept] if kept in self._force else self[kept] for shown, kept in self.PARTS[option].items()}

    def activateParkingBrake(self, mode: str):
        self._need(mode in ("engage", "release"), "Invalid mode")
        self["parkingBrakeStatus"] = mode + ("d" if mode.endswith("e") else "ed")
        self._force |= {"parked": PARKED_BRAKE if mode == "engage" else 0.0, "slope": SLOPE}
        return {"parkingBrakeStatus": self["parkingBrakeStatus"], "_parkingBrakeForce": self._force["parked"], "_slopeAngle": SLOPE}

    def _brake(self, force: float) -> dict:
        self["brakePedalStatus"], self._force["pressed"] = "pressed" if force else "released", force
        return {"brakePedalStatus": self["brakePedalStatus"], "brakePedalForce": float(force)}

    def pressBrakePedal(self, pedalPosition: float):
        self._need(0 <= pedalPosition <= 1, "Pedal position must be between 0 and 1.")
        return self._brake(pedalPosition * FULL_BRAKE if pedalPosition else 0.0)

    def releaseBrakePedal(self):
        return self._brake(0.0)

    def setCruiseControl(self, speed: float, activate: bool, distanceToNextVehicle: float):
        gap, speed = float(distanceToNextVehicle), float(speed)
        self._need(self["engineState"] != "stopped", "Start the engine before activating the cruise control.")
        self["distanceToNextVehicle"] = gap
        self._need(not activate or 0 <= speed <= 120 and speed % 5 == 0, "Invalid speed")
        self["cruiseStatus"] = "active" if activate else "inactive"
        return {"cruiseStatus": self["cruiseStatus"], "currentSpeed": speed, "distanceToNextVehicle": gap}

    def get_current_speed(self):
        return {"currentSpeed": self._chance.uniform(0.0, 120.0)}

    def display_log(self, messages: list):
        return {"log": messages}

    def estimate_drive_feasibility_by_mileage(self, distance: float):
        return {"canDrive": not self["fuelLevel"] * MILES_PER_GALLON < distance}

    def liter_to_gallon(self, liter: float):
        return {"gallon": liter * 0.264172}

    def gallon_to_liter(self, gallon: float):
        return {"liter": gallon * 3.78541}

    def estimate_distance(self, cityA: str, cityB: str):
        known = next((d for a, b, d in DISTANCES if {a, b} == {cityA, cityB}), None)
        self._need(known, "distance not found in database.")
        return {"distance": known}

    def get_zipcode_based_on_city(self, city: str):
        return {"zipcode": ZIPS.get(city, "00000")}

    def set_navigation(self, destination: str):
        self["destination"] = destination
        return {"status": f"Navigating to {destination}"}

    def check_tire_pressure(self):
        tires = {t: self[t] for t in self.TIRES}
        return {**tires, "healthy_tire_pressure": 30 <= sum(tires.values()) / 4 <= 35, "car_info": {}}

    def find_nearest_tire_shop(self):
        return {"shopLocation": TIRE_SHOP}


class Travel(Tool):
    """Bookings paid by registered cards, behind a token. Some calls tell by a flag of their own that they were refused."""

    DEFAULT = {
        "credit_card_list": {}, "booking_record": {}, "access_token": None, "token_type": None, "token_expires_in": None, "token_scope": None,
        "user_first_name": None, "user_last_name": None, "budget_limit": None,
    }
    BOOKED = ("travel_date", "travel_from", "travel_to", "travel_class", "travel_cost", "transaction_id")

    def _setup(self, config: dict) -> None:
        self._chance = random.Random(config.get("random_seed", SEED))

    def _digits(self, n: int) -> str:
        return str(self._chance.randint(10 ** (n - 1), 10**n - 1))

    def _token(self, token: str) -> None:
        self._need(self["token_expires_in"] != 0, "Token expired")
        self._need(token == self["access_token"], "Invalid access token")

    def _flagged(self, flag: str, call) -> dict:
        """What the call returns; if it is refused, the error and a flag that says so."""
        try:
            return call()
        except Refused as e:
            return {flag: False, "error": str(e)}

    def _booking(self, booking_id: str) -> dict:
        self._need(booking_id in self["booking_record"], "Booking not found")
        return self["booking_record"][booking_id]

    def authenticate_travel(self, client_id: str, client_secret: str, refresh_token: str, grant_type: str, user_first_name: str, user_last_name: str):
        self.state.update(token_expires_in=2, access_token=self._digits(6), token_type="Bearer", token_scope=grant_type, user_first_name=user_first_name, user_last_name=user_last_name)
        return {"expires_in": 2, "access_token": self["access_token"], "token_type": "Bearer", "scope": grant_type}

    def travel_get_login_status(self):
        return {"status": bool(self["token_expires_in"])}

    def get_budget_fiscal_year(self, lastModifiedAfter: str | None = None, includeRemoved: str | None = None):
        return {"budget_fiscal_year": "2018"}

    def register_credit_card(self, access_token: str, card_number: str, expiration_date: str, cardholder_name: str, card_verification_number: int):
        self._need(self["token_expires_in"] is not None, "Token not initialized")
        self._token(access_token)
        self._need(card_number not in self["credit_card_list"], "Card already registered")
        card = self._digits(12)
        self["credit_card_list"][card] = {
            "card_number": card_number, "expiration_date": expiration_date, "cardholder_name": cardholder_name, "card_verification_number": card_verification_number, "balance": int(self._digits(5)),
        }
        return {"card_id": card}

    def get_flight_cost(self, travel_from: str, travel_to: str, travel_date: str, travel_class: str):
        return {"travel_cost_list": [fare(travel_from, travel_to, travel_class, travel_date)]}

    def get_credit_card_balance(self, access_token: str, card_id: str):
        self._token(access_token)
        self._need(card_id in self["credit_card_list"], f"Card not registered. Here are a list of card_id's: {list(self['credit_card_list'])}")
        return {"card_balance": self["credit_card_list"][card_id]["balance"]}

    def book_flight(self, access_token: str, card_id: str, travel_date: str, travel_from: str, travel_to: str, travel_class: str):
        def book() -> dict:
            self._token(access_token)
            card = self["credit_card_list"].get(card_id)
            self._need(card is not None, "Card not registered")
            self._need("balance" in card, "Balance not found")
            self._need(travel_from in AIRPORTS.values(), f"Invalid departure airport code: {travel_from}")
            self._need(travel_to in AIRPORTS.values(), f"Invalid destination airport code: {travel_to}")
            try:
                datetime.datetime.strptime(travel_date, "%Y-%m-%d")
            except ValueError:
                raise Refused("Invalid date format. Use YYYY-MM-DD.") from None
            self._need(travel_class in CLASSES, f"Invalid travel class. Must be one of {sorted(CLASSES)}")
            try:
                cost = fare(travel_from, travel_to, travel_class, travel_date)
            except ValueError as e:
                raise Refused(str(e)) from None
            limit = self["budget_limit"]
            self._need(card["balance"] >= cost, "Insufficient funds")
            self._need(limit is None or card["balance"] >= limit, "Balance is less than budget limit")
            card["balance"] -= cost
            booking, transaction = self._digits(7), self._digits(8)
            values = (travel_date, travel_from, travel_to, travel_class, cost, transaction)
            self["booking_record"][booking] = {"card_id": card_id, **dict(zip(self.BOOKED, values))}
            return {"booking_id": booking, "transaction_id": transaction, "booking_status": True, "booking_history": {}}

        return self._flagged("booking_status", book)

    def retrieve_invoice(self, access_token: str, booking_id: str | None = None, insurance_id: str | None = None):
        self._token(access_token)
        record = self._booking(booking_id)
        return {"invoice": {"booking_id": booking_id, **{k: record[k] for k in self.BOOKED}}}

    def get_booking_history(self, access_token: str):
        self._token(access_token)
        return {"booking_history": copy.deepcopy(self["booking_record"])}

    def list_all_airports(self):
        return list(AIRPORTS.values())

    def cancel_booking(self, access_token: str, booking_id: str):
        def cancel() -> dict:
            self._token(access_token)
            record = self._booking(booking_id)
            self["credit_card_list"][record["card_id"]]["balance"] += record["travel_cost"]
            del self["booking_record"][booking_id]
            return {"cancel_status": True}

        return self._flagged("cancel_status", cancel)

    def compute_exchange_rate(self, base_currency: str, target_currency: str, value: float):
        if base_currency == "USD" and target_currency in RATES:
            return {"exchanged_value": float(value * RATES[target_currency])}
        if target_currency == "USD" and base_currency in RATES:
            return {"exchanged_value": round(value / RATES[base_currency], 2)}
        raise ValueError("No available exchange rate for the given currencies.")

    def verify_traveler_information(self, first_name: str, last_name: str, date_of_birth: str, passport_number: str):
        def verify() -> str | None:
            own = self["user_first_name"], self["user_last_name"]
            if own != (first_name, last_name):
                return f"Cannot book flight information for another user.Expected {own[0]} {own[1]}, got {first_name} {last_name}"
            try:
                born = datetime.datetime.strptime(date_of_birth, "%Y-%m-%d").date()
            except ValueError:
                return "Invalid date of birth format. Please use YYYY-MM-DD."
            today = datetime.date.today()
            if today.year - born.year - ((today.month, today.day) < (born.month, born.day)) < 18:
                return "Traveler must be at least 18 years old."
            return None if passport_number.startswith("US") else "Passport must be issued by the United States."

        wrong = verify()
        return {"verification_status": False, "verification_failure": wrong} if wrong else {"verification_status": True}

    def set_budget_limit(self, access_token: str, budget_limit: float):
        self._token(access_token)
        self["budget_limit"] = float(budget_limit)
        return {"budget_limit": self["budget_limit"]}

    def get_nearest_airport_by_city(self, location: str):
        return {"nearest_airport": AIRPORTS.get(location, "Unknown")}

    def purchase_insurance(self, access_token: str, insurance_type: str, booking_id: str, insurance_cost: float, card_id: str):
        def buy() -> dict:
            self._token(access_token)
            limit = self["budget_limit"]
            self._need(limit is None or limit >= insurance_cost, "Exceeded budget limit")
            self._booking(booking_id)
            self._need(card_id in self["credit_card_list"], "Credit card not registered")
            self["credit_card_list"][card_id]["balance"] -= insurance_cost
            return {"insurance_id": self._digits(9), "insurance_status": True}

        return self._flagged("insurance_status", buy)

    def contact_customer_support(self, booking_id: str, message: str):
        self._booking(booking_id)
        return {"customer_support_message": SUPPORT}

    def get_all_credit_cards(self):
        return {"credit_card_list": self["credit_card_list"]}
